"""CSS selectors as data, matched by joins and windows over the node table.

Supported: type, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]``, ``[a~=v]``,
``[a|=v]``, ``[a^=v]``, ``[a$=v]``, ``[a*=v]`` (with an ``i`` flag), the
descendant (space) and child (``>``) combinators and selector lists (``,``).
Anything else (pseudo-classes, sibling combinators) makes the selector invalid:
it matches nothing and ``valid`` is false in the compiled table.

Plan:
1. ``compile_selectors``: each distinct selector string becomes step rows
   (scope, selector, alt, step_no, n_steps, comb, tag, ids, classes, attrs, key)
   in one ``mapInArrow`` pass over the distinct strings.
2. Every element is expanded to its index terms (``*``, tag, classes, id,
   attribute names) and equi-joined with the step rows on (term[, domain], part).
   A small step table (row count checked) is a local relation with one part. A
   large one stays a table: a site with many pages is dealt out to parts by page
   and its step rows are repeated per part, so no site is one task; the number of
   parts follows from the site's share of all pages. The residual predicate checks
   the whole step.
3. The step chain is resolved with windows partitioned by
   (page_id, scope, selector, alt): descendant = running max of the previous
   step's ``end_id``; child = the parent is a previous-step match. All windows
   reuse the node table's ``page_id`` partitioning, so no further shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_LIMIT, materialize
from .shred import STRING_CONTAINERS, documents, elements

GLOBAL = ""  # scope of selectors that apply to every page

STEP_SCHEMA = (
    "scope string, selector string, valid boolean, alt int, step_no int, n_steps int, comb string, "
    "tag string, ids array<string>, classes array<string>, "
    "attrs array<struct<name:string,op:string,value:string,ci:boolean>>, key string"
)

_WS = " \t\n\r\f"


class SelectorError(ValueError):
    pass


def _ident(s: str, i: int):
    n = len(s)
    out = []
    start = i
    while i < n:
        c = s[i]
        if c == "\\":
            if i + 1 >= n:
                raise SelectorError("dangling escape")
            j = i + 1
            hexd = ""
            while j < n and len(hexd) < 6 and s[j] in "0123456789abcdefABCDEF":
                hexd += s[j]
                j += 1
            if hexd:
                if j < n and s[j] in _WS:
                    j += 1
                out.append(chr(int(hexd, 16)))
                i = j
            else:
                out.append(s[i + 1])
                i += 2
            continue
        if c.isalnum() or c in "-_" or ord(c) >= 0x80:
            out.append(c)
            i += 1
            continue
        break
    name = "".join(out)
    if not name or (s[start].isdigit()) or (len(s) > start + 1 and s[start] == "-" and s[start + 1].isdigit()):
        raise SelectorError("bad identifier")
    return name, i


def _string(s: str, i: int):
    q = s[i]
    i += 1
    out = []
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            out.append(s[i + 1])
            i += 2
            continue
        if c == q:
            return "".join(out), i + 1
        out.append(c)
        i += 1
    raise SelectorError("unterminated string")


def _skip_ws(s: str, i: int) -> int:
    while i < len(s) and s[i] in _WS:
        i += 1
    return i


def _attr(s: str, i: int):
    i = _skip_ws(s, i + 1)
    name, i = _ident(s, i)
    i = _skip_ws(s, i)
    if i < len(s) and s[i] == "]":
        return {"name": name.lower(), "op": "", "value": None, "ci": False}, i + 1
    op = None
    for cand in ("~=", "|=", "^=", "$=", "*=", "="):
        if s.startswith(cand, i):
            op = cand
            i += len(cand)
            break
    if op is None:
        raise SelectorError("bad attribute operator")
    i = _skip_ws(s, i)
    if i < len(s) and s[i] in "\"'":
        value, i = _string(s, i)
    else:
        value, i = _ident(s, i)
    i = _skip_ws(s, i)
    ci = False
    if i < len(s) and s[i] in "iIsS":
        ci = s[i] in "iI"
        i = _skip_ws(s, i + 1)
    if i >= len(s) or s[i] != "]":
        raise SelectorError("unclosed attribute")
    return {"name": name.lower(), "op": op, "value": value, "ci": ci}, i + 1


def _compound(s: str, i: int):
    start = i
    tag = None
    if s[i] == "*":
        i += 1
    elif s[i] not in "#.[:":
        tag, i = _ident(s, i)
        tag = tag.lower()
    ids, classes, attrs = [], [], []
    while i < len(s):
        c = s[i]
        if c == "#":
            v, i = _ident(s, i + 1)
            ids.append(v)
        elif c == ".":
            v, i = _ident(s, i + 1)
            classes.append(v)
        elif c == "[":
            a, i = _attr(s, i)
            attrs.append(a)
        elif c == ":":
            raise SelectorError("pseudo-classes are not supported")
        else:
            break
    if i == start:
        raise SelectorError("expected a selector")
    return {"tag": tag, "ids": ids, "classes": classes, "attrs": attrs}, i


def parse_selector(text):
    """Alternatives of a selector list, each a list of steps; SelectorError if unsupported."""
    if not isinstance(text, str):
        raise SelectorError("not a string")
    s = text.strip(_WS)
    if not s:
        raise SelectorError("empty selector")
    alts, steps, comb = [], [], None
    i = 0
    while i < len(s):
        c = s[i]
        if c in _WS:
            i = _skip_ws(s, i)
            if steps and comb is None:
                comb = " "
            continue
        if c in ">+~":
            if not steps or comb not in (None, " "):
                raise SelectorError("misplaced combinator")
            if c != ">":
                raise SelectorError("sibling combinators are not supported")
            comb = ">"
            i += 1
            continue
        if c == ",":
            if not steps or comb == ">":
                raise SelectorError("empty alternative")
            alts.append(steps)
            steps, comb = [], None
            i += 1
            continue
        step, i = _compound(s, i)
        step["comb"] = comb if steps else None
        steps.append(step)
        comb = None
    if not steps or comb == ">":
        raise SelectorError("dangling combinator")
    alts.append(steps)
    return alts


def _step_key(step) -> str:
    if step["ids"]:
        return "#" + step["ids"][0]
    if step["classes"]:
        return "c:" + step["classes"][0]
    if step["tag"]:
        return "t:" + step["tag"]
    if step["attrs"]:
        return "a:" + step["attrs"][0]["name"]
    return "*"


_STEP_ARROW = pa.schema([
    ("scope", pa.string()), ("selector", pa.string()), ("valid", pa.bool_()), ("alt", pa.int32()),
    ("step_no", pa.int32()), ("n_steps", pa.int32()), ("comb", pa.string()), ("tag", pa.string()),
    ("ids", pa.list_(pa.string())), ("classes", pa.list_(pa.string())),
    ("attrs", pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string()),
                                  ("ci", pa.bool_())]))),
    ("key", pa.string()),
])


def _compile_batches(batches):
    for batch in batches:
        out = {n: [] for n in _STEP_ARROW.names}
        for scope, sel in zip(batch.column("scope").to_pylist(), batch.column("selector").to_pylist()):
            try:
                alts = parse_selector(sel)
            except SelectorError:
                alts = None
            if alts is None:
                rows = [(False, None, None, None, None, None, [], [], [], None)]
            else:
                rows = []
                for a, steps in enumerate(alts):
                    for k, st in enumerate(steps, start=1):
                        rows.append((True, a, k, len(steps), st["comb"], st["tag"], st["ids"], st["classes"],
                                     st["attrs"], _step_key(st)))
            for r in rows:
                out["scope"].append(scope)
                out["selector"].append(sel)
                for name, v in zip(_STEP_ARROW.names[2:], r):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=_STEP_ARROW)


def compile_selectors(queries: DataFrame) -> DataFrame:
    """Step rows for the distinct (scope, selector) pairs of ``queries``.

    ``scope`` is a domain, or ``GLOBAL`` ('') / null for selectors that apply to
    every page. Invalid selectors give one row with ``valid = false``.
    """
    q = queries.select(F.coalesce(F.col("scope"), F.lit(GLOBAL)).alias("scope"), "selector").distinct()
    return q.mapInArrow(_compile_batches, STEP_SCHEMA)


def _terms(els: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per element and index term; with ``keys`` only those terms leave the element."""
    terms = F.array_distinct(F.flatten(F.array(
        F.array(F.lit("*"), F.concat(F.lit("t:"), F.col("tag"))),
        F.transform("classes", lambda c: F.concat(F.lit("c:"), c)),
        F.when(F.col("id").isNotNull(), F.array(F.concat(F.lit("#"), F.col("id")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.map_keys("attrs"), lambda a: F.concat(F.lit("a:"), a)),
    )))
    if keys is not None:
        terms = F.array_intersect(terms, F.array(*[F.lit(k) for k in keys]))
    return els.withColumn("term", F.explode(terms))


def _attr_value(name):
    return F.when(name == "class", F.array_join(F.col("classes"), " ")).otherwise(F.try_element_at(F.col("attrs"), name))


def _attr_ok(a):
    raw = _attr_value(a["name"])
    v = F.when(a["ci"], F.lower(raw)).otherwise(raw)
    x = F.when(a["ci"], F.lower(a["value"])).otherwise(a["value"])
    return (
        F.when(a["op"] == "", F.map_contains_key(F.col("attrs"), a["name"]))
        .when(v.isNull(), F.lit(False))
        .when(a["op"] == "=", v == x)
        .when(a["op"] == "~=", (x != "") & ~x.rlike(r"\s") & F.array_contains(F.split(v, r"\s+"), x))
        .when(a["op"] == "|=", (v == x) | v.startswith(F.concat(x, F.lit("-"))))
        .when(a["op"] == "^=", (x != "") & v.startswith(x))
        .when(a["op"] == "$=", (x != "") & v.endswith(x))
        .when(a["op"] == "*=", (x != "") & v.contains(x))
        .otherwise(F.lit(False))
    )


def _step_predicate():
    return (
        (F.col("s_tag").isNull() | (F.col("tag") == F.col("s_tag")))
        & F.forall("s_ids", lambda i: F.col("id") == i)
        & F.forall("s_classes", lambda c: F.array_contains(F.col("classes"), c))
        & F.forall("s_attrs", _attr_ok)
    )


# index terms that are tested as a literal array before the explode; more are left to the join
LITERAL_KEYS = 1_000
MATCH_COLS = ["page_id", "scope", "selector", "node_id", "end_id", "parent_id", "depth", "tag", "id",
              "classes", "attrs", "text", "text_lo", "text_hi"]


# a site with more than 1/HEAVY_SHARE of all pages is heavy, so there are fewer than HEAVY_SHARE heavy sites
HEAVY_SHARE = 2_000
PART_PAGES = 64  # pages of a part, at least
GLOBAL_PARTS = 32


def heavy_sites(nodes: DataFrame) -> DataFrame:
    """(heavy, parts): the sites whose pages are dealt out, and to how many parts.

    Fewer than ``HEAVY_SHARE`` rows whatever the input, and fewer than twice as many parts in all.
    """
    sizes = documents(nodes).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    total = documents(nodes).agg(F.count(F.lit(1))).scalar()
    parts = F.least(F.ceil(F.col("n") * HEAVY_SHARE / total), F.ceil(F.col("n") / PART_PAGES)).cast("int")
    return sizes.where(F.col("n") * HEAVY_SHARE > total).select(F.col("domain").alias("heavy"), parts.alias("parts")).where("parts > 1")


def _dealt(els: DataFrame, steps: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with the part of their page, and each site's steps once per part of the site."""
    of_page = F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("int"), F.lit(0))
    els = els.join(F.broadcast(heavy), F.col("domain") == F.col("heavy"), "left").withColumn("part", of_page).drop("heavy", "parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    steps = steps.join(F.broadcast(heavy), F.col("scope") == F.col("heavy"), "left").withColumn("s_part", every).drop("heavy", "parts")
    return els, steps


def match(nodes: DataFrame, queries: DataFrame, strict: bool = False) -> DataFrame:
    """All elements matching each (scope, selector) of ``queries``.

    Returns MATCH_COLS: one row per (page, scope, selector, matching element).
    A global selector is matched on every page; a scoped one only on pages of
    that domain. ``strict`` raises on selectors outside the grammar, which else match nothing.
    """
    spark = nodes.sparkSession
    steps = compile_selectors(queries)
    head = steps.limit(BROADCAST_ROW_LIMIT + 1).collect()
    bcast = len(head) <= BROADCAST_ROW_LIMIT
    if bcast:
        bad = [r["selector"] for r in head if not r["valid"]]
        head = [r for r in head if r["valid"]]
    else:
        steps = materialize(steps, "steps")
        bad = [r["selector"] for r in steps.filter(~F.col("valid")).take(5)] if strict else []
    if strict and bad:
        raise ValueError(f"unsupported selectors, e.g. {sorted(set(bad))[:5]}")
    if bcast:
        if not head:
            return spark.createDataFrame([], _match_schema(nodes))
        steps = spark.createDataFrame(head, steps.schema)
        stats = {"n": len(head), "k": max(r["n_steps"] for r in head),
                 "g": sum(1 for r in head if r["scope"] == GLOBAL)}
    else:
        steps = steps.filter("valid")
        stats = steps.agg(F.count(F.lit(1)).alias("n"), F.max("n_steps").alias("k"),
                          F.count_if(F.col("scope") == GLOBAL).alias("g")).first()
    s = steps.select(
        "scope", "selector", "alt", "step_no", "n_steps", "comb", F.col("tag").alias("s_tag"),
        F.col("ids").alias("s_ids"), F.col("classes").alias("s_classes"), F.col("attrs").alias("s_attrs"), "key")
    keys = sorted({r["key"] for r in head if r["key"] is not None}) if bcast else []
    els = elements(nodes)
    glob, site = s.filter(F.col("scope") == GLOBAL), s.filter(F.col("scope") != GLOBAL)
    on_term = F.col("term") == F.col("key")
    parts = []
    if bcast:
        terms = _terms(els, keys if 0 < len(keys) <= LITERAL_KEYS else None)
        if stats["g"] > 0:
            parts.append(terms.join(F.broadcast(glob), on_term))
        if stats["g"] < stats["n"]:
            parts.append(terms.join(F.broadcast(site), on_term & (F.col("domain") == F.col("scope"))))
    else:
        if stats["g"] > 0:
            terms = _terms(els).withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(GLOBAL_PARTS)))
            every = glob.withColumn("s_part", F.explode(F.sequence(F.lit(0), F.lit(GLOBAL_PARTS - 1))))
            parts.append(terms.join(every, on_term & (F.col("part") == F.col("s_part"))).drop("part", "s_part"))
        if stats["g"] < stats["n"]:
            dealt, every = _dealt(els, site, heavy_sites(nodes))
            same = on_term & (F.col("domain") == F.col("scope")) & (F.col("part") == F.col("s_part"))
            parts.append(_terms(dealt).join(every, same).drop("part", "s_part"))
    cand = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    cand = cand.filter(_step_predicate()).select(*MATCH_COLS, "alt", "step_no", "n_steps", "comb")
    if not bcast:
        cand = cand.repartition("page_id")
    cand = cand.withColumn("alive", F.col("step_no") == 1)
    key = ["page_id", "scope", "selector", "alt"]
    for k in range(2, (stats["k"] or 1) + 1):
        prev = (F.col("step_no") == k - 1) & F.col("alive")
        here = F.col("step_no") == k
        w_desc = Window.partitionBy(*key).orderBy("node_id", F.when(here, 0).otherwise(1)).rowsBetween(
            Window.unboundedPreceding, -1)
        reach = F.max(F.when(prev, F.col("end_id"))).over(w_desc)
        link = F.when(prev, F.col("node_id")).when(here & (F.col("comb") == ">"), F.col("parent_id"))
        cand = cand.withColumn("_link", link)
        has_parent = F.max(F.when(prev, 1).otherwise(0)).over(Window.partitionBy(*key, "_link"))
        cand = cand.withColumn(
            "alive",
            F.when(here & (F.col("comb") == " "), F.coalesce(reach >= F.col("node_id"), F.lit(False)))
            .when(here & (F.col("comb") == ">"), F.col("_link").isNotNull() & (has_parent == 1))
            .otherwise(F.col("alive")),
        ).drop("_link")
    done = cand.filter(F.col("alive") & (F.col("step_no") == F.col("n_steps")))
    return done.select(*MATCH_COLS).dropDuplicates(["page_id", "scope", "selector", "node_id"])


def _match_schema(nodes: DataFrame):
    from pyspark.sql.types import StringType, StructField, StructType
    fields = []
    for c in MATCH_COLS:
        if c in ("scope", "selector"):
            fields.append(StructField(c, StringType()))
        else:
            fields.append(nodes.schema[c])
    return StructType(fields)


def first_match(matches: DataFrame) -> DataFrame:
    """J3 select_one: the first match in document order per (page, scope, selector)."""
    rest = [c for c in MATCH_COLS if c not in ("page_id", "scope", "selector")]
    first = F.min_by(F.struct(*rest), F.col("node_id")).alias("m")
    return matches.groupBy("page_id", "scope", "selector").agg(first).select("page_id", "scope", "selector", "m.*")


def match_counts(matches: DataFrame) -> DataFrame:
    """A4: number of matches per (page, scope, selector)."""
    return matches.groupBy("page_id", "scope", "selector").agg(F.count(F.lit(1)).alias("n_matches"))


def text_of(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """F10 get_text(strip=True) of matched elements, as column ``value``.

    Stripped text pieces of the page are laid out in the document row's text;
    an element's text is its ``[text_lo, text_hi)`` slice. Script, style and the
    other string containers use their own text. Joined on ``page_id`` only, so the
    join is co-partitioned with the node table.
    """
    docs = nodes.filter(F.col("kind") == "document").select("page_id", F.col("text").alias("_page_text"))
    own = F.col("tag").isin(*sorted(STRING_CONTAINERS))
    value = F.when(own, F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.col("_page_text").substr(F.col("text_lo") + 1, F.col("text_hi") - F.col("text_lo")))
    return matched.join(docs, "page_id").withColumn("value", value).drop("_page_text")
